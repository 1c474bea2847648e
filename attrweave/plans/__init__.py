"""Whole runs composed of operators, and the query catalogue."""
