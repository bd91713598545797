"""Readers and writers: tiles, file listings, metadata documents, project
snapshots, provenance logs, trace exports."""
