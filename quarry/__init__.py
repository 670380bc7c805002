"""quarry: repository and document quality analytics as Spark jobs."""
