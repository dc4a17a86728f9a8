"""Column expressions shared by every job."""
