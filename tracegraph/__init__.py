"""Attribution-graph analytics on Spark DataFrames."""
