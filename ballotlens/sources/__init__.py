"""Readers and writers for the file layouts used around election audits."""
