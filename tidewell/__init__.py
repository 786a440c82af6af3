"""A PySpark engine for rolling analytics over public social posts."""
