"""Event features, snapshots and point-in-time training sets as Spark DataFrames."""
