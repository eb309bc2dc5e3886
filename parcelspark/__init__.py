"""Property-market analytics on Spark: profiling, price models, request scoring,
document chunking, embedding, upsert and top-k retrieval, all as DataFrame jobs."""

__version__ = "0.1.0"
