"""Readers and writers of recordings, label tables, manifests and datasets."""
