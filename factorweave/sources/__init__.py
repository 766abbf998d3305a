"""Panels, factor files and reports: reading and writing."""
