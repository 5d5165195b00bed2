"""Readers, writers, schemas and the staging area."""
