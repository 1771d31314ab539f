"""Domain operators: matching, enrichment, bootstrap, entities, ontology, aggregation."""
