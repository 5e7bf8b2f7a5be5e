"""DataFrame operators: DataFrames in, DataFrames out, no data-sized collect."""
