"""Gene-family analytics on PySpark DataFrames."""
