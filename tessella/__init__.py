"""Tables of pixels, points, seeds, clusters and graphs as Spark DataFrames."""
