"""Signal-quality analytics on Spark."""
