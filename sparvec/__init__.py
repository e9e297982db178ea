"""Training-free vector quantisation and similarity search on Spark DataFrames."""
