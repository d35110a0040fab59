"""The row-level operators and window counts on streams."""
