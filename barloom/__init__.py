"""barloom: market-bar analytics on PySpark DataFrames."""
