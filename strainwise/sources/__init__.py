"""Readers, layout mappings, roster header handling and sinks."""
