"""Operators over the node and edge tables, as DataFrame transformations."""
