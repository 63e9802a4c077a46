"""Declarative plans built from operators."""
