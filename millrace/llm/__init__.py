"""Operators of a training-data pipeline over text tables (documents, pages, conversations).

The subpackage is self-contained: nothing else in the library imports it.
"""
