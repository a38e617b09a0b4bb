"""pagelens: page and corpus analytics on Spark DataFrames."""
