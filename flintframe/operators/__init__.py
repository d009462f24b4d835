"""Operators over contours, surfaces and the metrics table."""
