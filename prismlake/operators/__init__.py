"""Operators over the media index."""
