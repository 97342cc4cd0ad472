"""Readers, archives and exports."""
