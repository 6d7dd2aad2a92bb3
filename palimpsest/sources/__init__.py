"""Reading and writing the relations."""
