"""Functions on bytes and values, without Spark."""
