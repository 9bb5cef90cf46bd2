"""Operators for preparing training text: filters, deduplication, tokenisation, scoring and formatting.

Nothing outside this subpackage imports it. Every operator takes DataFrames and returns DataFrames, keeps extra
columns out of its way, and states in its docstring what null, empty and repeated rows give.
"""
