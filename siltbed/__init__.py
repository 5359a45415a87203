"""siltbed: coreset clustering and corpus preparation on PySpark DataFrames."""
