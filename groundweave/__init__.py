"""Land-cover analytics on pixel tables, written with Spark DataFrames."""
