"""Operators on text for training-data work; nothing else in the library imports this subpackage."""
