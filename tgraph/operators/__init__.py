"""Operators over edge tables."""
