"""Classical machine-learning analytics over Spark DataFrames."""
