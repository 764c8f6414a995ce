"""Part of kbspark: sources."""
