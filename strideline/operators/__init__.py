"""DataFrame operators: every function maps DataFrames and a spec to a lazy DataFrame."""
