"""Registered queries: each maps driver tables onto an operator's input
shape (``fixtures``), runs the operator, and carries a DuckDB oracle."""
