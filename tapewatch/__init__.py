"""Trade surveillance operators on Spark DataFrames."""
