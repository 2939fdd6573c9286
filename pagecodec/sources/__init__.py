"""Reading and writing pages."""
