"""Operators of a training-data pipeline over the text tables. Nothing outside this subpackage imports it."""
