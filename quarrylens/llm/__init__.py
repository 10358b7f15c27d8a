"""Training-data operators.

Every operator is a function from DataFrames to a DataFrame (or to files that it
reads back).  Nothing outside this subpackage imports it.
"""
