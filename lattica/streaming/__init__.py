"""Part of lattica: streaming."""
