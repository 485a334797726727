"""knowmill: retrieval, hierarchy and corpus analytics over project knowledge, as Spark jobs."""
