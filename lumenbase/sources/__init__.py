"""Readers for the catalogue's file formats and logs."""
