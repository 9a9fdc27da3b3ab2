"""mnemospark: conversation, document and embedding analytics on Spark DataFrames."""
