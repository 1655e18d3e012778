"""Readers: files and table columns as rows of triples, cells, links and attributes."""
