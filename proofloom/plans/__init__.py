"""Corpus assembly, the query catalogue and its SQL counterparts."""
