"""Operators of a training-data pipeline over the tables of text, labels, pages and conversations."""
