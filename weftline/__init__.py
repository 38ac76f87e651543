"""weftline: text-corpus and learning-data analytics on PySpark DataFrames."""
