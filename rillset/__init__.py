"""rillset: incremental views over signed multisets, on Spark DataFrames."""
