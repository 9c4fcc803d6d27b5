"""Named query catalogue (``catalog``) and the DuckDB oracle SQL (``oracle``)."""
