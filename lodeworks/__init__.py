"""lodeworks: document-retrieval evaluation as Spark jobs."""
