"""Change detection over pixel time series, as Spark DataFrames."""
