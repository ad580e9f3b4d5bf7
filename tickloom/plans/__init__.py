"""Whole analyses, composed from operators, and the queries over the driver's tables."""
