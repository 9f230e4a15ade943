"""Readers and writers: history files, journals, victories, sheets."""
