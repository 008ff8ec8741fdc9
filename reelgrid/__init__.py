"""reelgrid: footage analytics on Spark DataFrames."""
