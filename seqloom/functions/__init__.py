"""Part of the sequence engine."""
