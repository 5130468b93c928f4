"""Operators over property graphs and their pattern tables."""
