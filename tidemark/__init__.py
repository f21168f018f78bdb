"""tidemark: market time series, ledgers and training-data preparation as Spark jobs."""
