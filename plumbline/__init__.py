"""plumbline: judge vector data against a trusted reference set with Spark DataFrames."""
