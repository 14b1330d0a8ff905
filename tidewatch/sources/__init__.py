"""Source tables: schemas, loading, catalog look-ups and the star-schema adapters."""
