"""ringlight: point-in-time identity-ring analytics on Spark DataFrames."""
