"""Part of lattica: operators."""
