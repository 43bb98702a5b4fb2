"""folioflow: document-evidence analytics on Spark DataFrames."""
