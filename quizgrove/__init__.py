"""Question-bank analytics on PySpark DataFrames."""
