"""Evidence-enrichment analytics as Spark jobs."""
