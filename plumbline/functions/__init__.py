"""Expressions: columns, conditions, calculations and windows, with the facts the checks need."""
