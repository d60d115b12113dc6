"""skein: source-code analytics expressed as Spark DataFrames."""
