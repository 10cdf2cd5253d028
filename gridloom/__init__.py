"""Raster tiling, tile-archive analytics and corpus preparation on Spark DataFrames."""
