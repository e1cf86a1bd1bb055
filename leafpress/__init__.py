"""Clean-page extraction and text-table operators on Spark DataFrames."""
