"""Operators for the data of language models; nothing outside this package imports it."""
