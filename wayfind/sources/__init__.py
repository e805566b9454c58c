"""Readers, chunking, knowledge-graph projection, profiles and sinks."""
