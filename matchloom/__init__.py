"""matchloom: record linkage and training-data preparation on Spark DataFrames."""
