"""Part of kbspark: operators."""
