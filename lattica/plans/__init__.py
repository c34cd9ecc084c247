"""Part of lattica: plans."""
