"""Access-log analytics on Spark."""
