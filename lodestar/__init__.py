"""lodestar: a Spark-first retrieval, graph and evaluation engine."""
