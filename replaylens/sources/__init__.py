"""Readers and writers for sessions, chunks, masks, state logs and tables."""
