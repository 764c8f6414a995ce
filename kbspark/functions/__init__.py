"""Part of kbspark: functions."""
