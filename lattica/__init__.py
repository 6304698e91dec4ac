"""lattica: code-architecture analytics and training-data operators on Spark DataFrames."""
