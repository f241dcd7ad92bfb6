"""Spark-first analytics over software structure, history and runtime traces."""
