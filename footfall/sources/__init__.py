"""Readers and writers of raw logs, feeds and tables."""
