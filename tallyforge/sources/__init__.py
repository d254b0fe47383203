"""Reading tables and the statement formats."""
