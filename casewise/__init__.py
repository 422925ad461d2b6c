"""Case-partitioned time-series analytics on Spark DataFrames."""
