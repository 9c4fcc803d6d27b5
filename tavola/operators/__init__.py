"""Spark operators: reports, floor views, pair mining, set-based jobs, quality checks."""
