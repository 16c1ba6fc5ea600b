"""sparkfolio: document analytics on Spark DataFrames."""
