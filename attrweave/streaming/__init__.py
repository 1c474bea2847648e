"""Incremental intake of specifications."""
