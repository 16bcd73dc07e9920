"""Operators for building training corpora from document and page tables."""
