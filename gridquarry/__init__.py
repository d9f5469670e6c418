"""A Spark engine for gridded time series and forecast verification."""
