"""lexarium: corpus indexing, hybrid retrieval and corpus preparation as Spark jobs."""
