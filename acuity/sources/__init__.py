"""Reading raw files, stored tables and shared scratch tables."""
