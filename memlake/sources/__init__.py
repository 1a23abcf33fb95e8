"""Readers, and the views over the tables that operators work on."""
