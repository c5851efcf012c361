"""Spark-first analytics over source-code diagnostics: ingest, query language, history, teams and data quality."""
