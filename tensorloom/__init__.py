"""Model-tensor analytics on Spark: weight files, their metadata, lineage and checks as DataFrames."""
