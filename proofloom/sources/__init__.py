"""Readers: relational tables, JSON snapshots and merged corpora."""
