"""Operators of a training-data pipeline over a text corpus.  Nothing else in the library imports them."""
