"""Web knowledge-graph analytics on PySpark: DataFrames in, DataFrames out."""
