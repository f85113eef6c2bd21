"""Financial event analytics on Spark."""
