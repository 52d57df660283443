"""A document-query engine that compiles to Spark plans."""
