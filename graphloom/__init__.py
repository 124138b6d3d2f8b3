"""graphloom: tables of documents to validated, ontology-typed graphs, as Spark plans."""

__version__ = "0.1.0"
