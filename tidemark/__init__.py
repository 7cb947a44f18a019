"""Order-book survival and execution analytics on Spark."""
