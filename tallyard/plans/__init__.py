"""Query modules; each has QUERIES (name to function of session and folder) and SQL (name to DuckDB text)."""

MODULES = ("general", "relational", "aggregates", "text", "windows", "statistics", "resampling", "similarity", "learning", "streams")
