"""Readers and writers: corpus manifest, text/JSON/XML/HTML grids, the fact store."""
