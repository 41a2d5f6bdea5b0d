"""Queries by area; each module registers its own."""
