"""Queries over the fixture tables and their oracles."""
