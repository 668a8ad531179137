"""Column functions: everything here builds expressions or is plain Python, and runs no job."""
