"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns a DataFrame; ``queries.py`` holds the thin driver queries.
"""
