"""Comparative ranking of scored hits on Spark: sources, operators, statistics and plans."""
