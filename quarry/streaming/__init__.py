"""File-change streams."""
