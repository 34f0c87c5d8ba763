"""Corpus and ontology analytics expressed as Spark DataFrame plans."""
