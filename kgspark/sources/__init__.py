"""Readers and writers of pages, cards, tables and graphs."""
