"""Check workload: log tables derived from the driver's parquet, the queries over them, and their SQL."""
