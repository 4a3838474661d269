"""Quarry: document-structure analytics over collections of PDF files, as Spark tables."""
