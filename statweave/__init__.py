"""Statistics, time series and clustering over tables, as Spark plans."""
