"""Readers and writers: text formats, binary formats, and the level store."""
