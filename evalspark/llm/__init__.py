"""Operators of a training-data pipeline over a corpus of documents.

Nothing else in the library imports this subpackage.  Every operator takes its
column names as parameters, selects only those columns, and so is unaffected by
further columns of any name.
"""
