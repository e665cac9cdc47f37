"""Point-in-time forecasting analytics on Spark DataFrames."""
