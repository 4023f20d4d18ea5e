"""Planning helpers: lineage cuts in shared storage, sizing, loops."""
