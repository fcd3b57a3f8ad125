"""Readers and writers of the stores: event log, blobs, transcripts, manifests, presence, git heads, a tailing stream."""
