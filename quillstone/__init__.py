"""Case notes to reviewed form answers as DataFrame operations."""
