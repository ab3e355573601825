"""Training-data operators (tokenising, deduplication, scoring, mixing).

Self-contained: nothing else in the library imports this subpackage.
"""
