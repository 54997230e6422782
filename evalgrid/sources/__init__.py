"""Reading and writing the stored tables and files."""
