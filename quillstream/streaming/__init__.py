"""Stateful twins of the admission operators."""
