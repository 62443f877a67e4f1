"""From the syntax tree to DataFrames and Columns."""
