"""Structure and history of codebases as Spark DataFrames."""
