"""Part of lattica: sources."""
