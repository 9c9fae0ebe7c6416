"""Sources of blocks and edges."""
