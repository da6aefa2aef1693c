"""Block analytics on Spark: DataFrame operators for block-structured data."""
