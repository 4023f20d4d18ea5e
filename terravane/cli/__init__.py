"""Command line: convert, pyramid, validate, info."""
