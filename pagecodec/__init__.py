"""pagecodec: cascading columnar compression and encoded-domain analytics on Spark DataFrames."""
