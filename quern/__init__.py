"""Text-corpus engine on Spark DataFrames."""
