"""Operators on training texts. Nothing else in the library imports this subpackage."""
