"""Smart-meter analytics on Spark DataFrames."""
