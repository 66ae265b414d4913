"""placemill: clean place directories from many overlapping sources, on Spark DataFrames."""

__version__ = "0.1.0"
