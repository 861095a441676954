"""decaytrace: find, price and verify silent model decay with plain Spark DataFrames."""
