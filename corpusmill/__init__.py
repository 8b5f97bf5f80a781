"""Document enrichment, versioning and retrieval as Spark jobs."""
