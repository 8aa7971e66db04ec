"""spindle: full-text search and relevance on Spark DataFrames."""
