"""Loads and exports."""
