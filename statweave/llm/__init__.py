"""Training-data operators: search, scans, scoring, packing, deduplication.

Nothing else in the library imports this subpackage.  ``registry`` holds the
queries and their SQL.
"""
