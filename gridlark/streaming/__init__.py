"""Views over files that keep arriving."""
