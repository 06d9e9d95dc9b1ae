"""docloom: corpus processing, hybrid retrieval and evaluation as Spark DataFrame jobs."""
