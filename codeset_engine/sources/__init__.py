"""Readers and writers: listings, code files, documents, archives, link pages, stored tables."""
