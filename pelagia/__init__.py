"""Spark-first analytics over image catalogues, pixel arrays and training corpora."""
