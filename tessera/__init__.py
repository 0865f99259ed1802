"""Tessera: a Spark-first retrieval, quality and usage-analytics engine for team memories."""
