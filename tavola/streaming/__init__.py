"""Structured Streaming versions of the change-driven rules (see ``feeds``)."""
