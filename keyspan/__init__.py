"""A deterministic algebra of immutable keyed collections, as Spark DataFrames."""
