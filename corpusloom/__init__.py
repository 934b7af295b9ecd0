"""corpusloom: corpus, graph, identity, retrieval and audit operators on Spark DataFrames."""
