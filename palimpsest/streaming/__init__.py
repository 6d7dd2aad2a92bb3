"""The state functions over streams."""
