"""inkstream: news and document analytics on PySpark DataFrames."""
