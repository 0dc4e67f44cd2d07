"""lectern: document retrieval analytics expressed as Spark DataFrames."""
