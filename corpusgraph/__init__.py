"""Batch and streaming jobs that turn document collections into searchable, connected
knowledge, for many tenants at once."""
