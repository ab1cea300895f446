"""Reusable relational building blocks: dedupe, ordered fills, lookups, reshaping."""
