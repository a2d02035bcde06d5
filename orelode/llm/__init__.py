"""Operators on texts and source files for training data. Nothing else in the library imports this subpackage."""
