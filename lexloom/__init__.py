"""lexloom: ranked text retrieval and text-corpus processing on Spark DataFrames."""
