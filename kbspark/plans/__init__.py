"""Part of kbspark: plans."""
