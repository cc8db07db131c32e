"""Operators for preparing training text at scale.

Every operator takes and returns DataFrames, works on whole texts, and states in its docstring what
it returns for nulls, empty texts, repeated rows and empty tables.  Nothing outside this subpackage
imports it.
"""
