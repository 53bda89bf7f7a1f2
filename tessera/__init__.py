"""Text-and-embedding analytics on Spark."""
