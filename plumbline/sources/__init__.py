"""Readers that turn survey files into tables."""
