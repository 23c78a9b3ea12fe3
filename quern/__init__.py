"""quern: a knowledge store, hybrid retrieval and graph analytics as Spark DataFrames."""
