"""Operators on lowered DataFrames: checks, sinks, workbooks, pivots, lineage and ordered runs."""
