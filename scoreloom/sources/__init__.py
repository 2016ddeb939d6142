"""Readers and writers for question banks, run tables and report files."""
