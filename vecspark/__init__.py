"""Vector collections, payload filters and similarity search as Spark jobs."""
