"""Operators for preparing training corpora: scoring, archives, deduplication, sharding, packing.

Each module holds one operator with its own interface; ``registry`` holds the queries that apply them to
the tables, with their SQL where SQL can express them. Nothing else in the library imports this package.
"""
