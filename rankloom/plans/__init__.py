"""Run options, whole plans, and the catalogue of queries."""
