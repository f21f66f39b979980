"""Readers and writers: block stores, project files, point tables, pyramids, virtual views."""
