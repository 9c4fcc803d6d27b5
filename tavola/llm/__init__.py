"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  Each operator lives in a
module of its own; ``queries.py`` applies them to the tables of a folder.
"""
