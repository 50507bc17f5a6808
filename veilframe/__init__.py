"""Sensitive-data masking and corpus preparation as DataFrame operators."""

__version__ = "0.1.0"
