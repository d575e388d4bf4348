"""Operators for building language-model training data. Self-contained: no
other part of the library imports this subpackage."""
