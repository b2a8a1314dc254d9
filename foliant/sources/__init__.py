"""Readers and writers: documents, extraction JSON, line JSON, web pages, snapshots."""
