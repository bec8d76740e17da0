"""Long-term text memory analytics on Spark: DataFrame in, DataFrame out."""
