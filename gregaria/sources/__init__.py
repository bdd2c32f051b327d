"""Readers of tables and graphs, and the shared scratch folder."""
