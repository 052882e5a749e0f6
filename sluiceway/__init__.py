"""sluiceway: web-document and document-structure analytics, expressed as Spark plans."""
