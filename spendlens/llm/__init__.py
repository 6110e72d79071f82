"""Operators for preparing language-model training data (documents, pages).

Nothing outside this subpackage imports it. Every operator takes DataFrames
and returns a DataFrame; `queries` applies each one to its whole table.
"""
