"""A declarative concept language that runs on Spark DataFrames."""
