"""lodestream: relational, text, vector and event-time operations on Spark DataFrames."""
