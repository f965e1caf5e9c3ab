"""Operators on code graphs as DataFrame plans."""
