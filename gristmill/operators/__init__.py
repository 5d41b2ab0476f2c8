"""Operators over candidate, scored and result tables."""
