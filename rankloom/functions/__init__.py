"""Column functions: statistics, sequences, packed cells, colours."""
