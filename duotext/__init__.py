"""duotext: refine parallel corpora and training text with Spark DataFrames."""
