"""Domain operators: DataFrames in, DataFrame out."""
