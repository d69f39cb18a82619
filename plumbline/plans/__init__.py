"""Statements: clauses, their checks, keys, and lowering to DataFrames."""
