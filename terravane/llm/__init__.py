"""Training-data operators over text tables; nothing outside this subpackage imports it."""
