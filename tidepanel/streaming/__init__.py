"""Incremental and streaming counterparts of the batch operators."""
