"""Readers and writers: records, vectors, reports, run metadata, models."""
