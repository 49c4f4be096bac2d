"""ctxspark: code- and document-context retrieval on Spark DataFrames."""
