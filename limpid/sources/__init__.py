"""Reading messy files into tables and writing results."""
