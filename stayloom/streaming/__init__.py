"""The same tables from files as they come in."""
