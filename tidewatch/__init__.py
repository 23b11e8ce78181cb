"""Media-monitoring analytics on Spark."""
