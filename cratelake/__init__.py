"""Spark-first analytics over large media-asset catalogues."""
