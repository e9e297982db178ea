"""Readers and writers: index files, raw matrices, metadata, blobs."""
