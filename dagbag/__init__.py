"""Map-reduce analytics over version histories, on PySpark DataFrames."""
