"""Relational operators over DataFrames with column-name parameters."""
