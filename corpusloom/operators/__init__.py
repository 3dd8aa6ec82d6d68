"""Operators of corpusloom."""
