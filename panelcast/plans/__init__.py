"""Composed query plans and their engine-neutral presentation."""
