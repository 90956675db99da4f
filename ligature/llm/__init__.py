"""Operators for preparing training text, each by one named method; nothing else in the package imports this."""
