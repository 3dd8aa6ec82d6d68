"""Sources of corpusloom."""
