"""Operators on DataFrames of hits, clusters, trees, alignments and annotation."""
