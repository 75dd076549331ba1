"""Landed inputs normalized into one posting shape, and the tables written from it."""
