"""lexispark: vocabulary building and study analytics on Spark DataFrames."""
