"""Relational operators over asset, prim and edge tables."""
