"""Analytics for scholarly-style corpora, declared on Spark DataFrames."""
