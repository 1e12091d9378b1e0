"""Operators for preparing training text: filtering, deduplication, scoring, mixing and tokenising."""
