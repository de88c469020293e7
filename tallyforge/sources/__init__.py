"""Schemas, loaders and the snapshot store."""
