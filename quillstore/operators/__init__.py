"""Relational and store operators as DataFrame plans."""
