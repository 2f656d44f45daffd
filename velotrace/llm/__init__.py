"""Operators for text and large-model data; nothing outside this package imports it."""
