"""Spark-first analytics engine for large media catalogs."""
