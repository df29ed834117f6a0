"""Certain answers over inconsistent tables, on Spark DataFrames."""
