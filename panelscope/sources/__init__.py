"""Readers and writers: request lines, reports, manifests, the store."""
