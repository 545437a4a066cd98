"""Network-flow security analytics on Spark."""
