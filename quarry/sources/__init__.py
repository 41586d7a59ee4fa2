"""Files and document formats."""
