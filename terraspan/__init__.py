"""Regional time-series analytics expressed as Spark DataFrame plans."""
