"""Files and tables: where output goes, how it is written, read back and listed."""
