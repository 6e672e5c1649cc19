"""codelode: software-project analytics and training-data operators on Spark DataFrames."""
