"""Part of the duplicate and similarity engine."""
