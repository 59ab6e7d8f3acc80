"""Readers and extractors: CSV with a header found by content, HTML, JSON-LD, XML feeds and items, paged APIs; and sinks."""
