"""factlens: facts extracted from documents, as Spark jobs."""
