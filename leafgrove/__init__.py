"""leafgrove: a Spark-first engine for structural document retrieval at collection scale."""
