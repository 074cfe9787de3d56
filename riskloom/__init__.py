"""riskloom: entity-history profiling, rank metrics and ensembles on Spark DataFrames."""
