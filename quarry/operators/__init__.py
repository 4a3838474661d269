"""Queries over the tables of PDF files."""
