"""Operators of a training-data pipeline over documents, pages and conversations.

Nothing outside this subpackage imports it. ``queries.CASES`` holds the
registered queries; the operators take and return DataFrames.
"""
