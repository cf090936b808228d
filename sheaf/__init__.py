"""sheaf: tabular extraction and corpus operators on Spark DataFrames."""
