"""Training-data operators over documents and web pages.

Nothing else in the library imports this package.  Each module holds one
operator with its own interface; ``queries.py`` registers the thin
``opN_<name>`` queries and their SQL.
"""
