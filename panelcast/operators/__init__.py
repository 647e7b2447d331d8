"""Operators over panels: quality, features, relations, splits, models."""
