"""Incremental reports over observation streams."""
