"""quireflow: document processing and translation-quality analytics on Spark DataFrames."""
