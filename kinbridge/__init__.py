"""Entity resolution and training-data operators on Spark DataFrames."""
