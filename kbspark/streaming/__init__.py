"""Part of kbspark: streaming."""
