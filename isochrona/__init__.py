"""Door-to-door travel analytics on Spark: timetables, streets, matrices, frontiers, fares and emissions as DataFrames."""

__version__ = "0.1.0"
