"""Readers, writers and admission of files."""
