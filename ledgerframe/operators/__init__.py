"""The analyses, each from DataFrames to DataFrames."""
