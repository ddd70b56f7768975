"""thicket: a knowledge-graph analytics engine on Spark DataFrames."""
