"""Operators over blocks, edges and tombstones."""
