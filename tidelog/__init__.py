"""tidelog: time-series tables kept as a versioned change log, on Spark DataFrames."""
