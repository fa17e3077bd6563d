"""Quillstone: retrieval, catalog maintenance and training-data operators on Spark DataFrames."""
