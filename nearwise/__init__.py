"""k-nearest-neighbour analytics over two-dimensional points, on Spark DataFrames."""
