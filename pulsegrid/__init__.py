"""Fleet telemetry analytics on Spark: typed tables in, series, rates, logs and reports out."""
