"""foliant: document analytics on PySpark DataFrames."""
