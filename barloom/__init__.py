"""Barloom: ordered-series features, labels, analytics and ledgers as Spark DataFrames."""
