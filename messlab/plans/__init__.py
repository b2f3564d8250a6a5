"""Specifications turned into tables, files, page dumps and run summaries."""
