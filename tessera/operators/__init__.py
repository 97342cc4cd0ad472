"""Operators over memory tables."""
