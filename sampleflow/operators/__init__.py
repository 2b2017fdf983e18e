"""Operators over ordered DataFrames: each takes and gives one with ``__pos``."""
