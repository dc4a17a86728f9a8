"""Readers, writers and the adapter that maps the test tables to ticket tables."""
