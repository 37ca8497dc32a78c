"""Static analysis of script corpora as Spark tables and queries."""
