"""Streaming forms of intake, de-duplication and the context join."""
