"""Text search and text analytics on PySpark DataFrames."""
