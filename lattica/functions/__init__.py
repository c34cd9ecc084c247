"""Part of lattica: functions."""
