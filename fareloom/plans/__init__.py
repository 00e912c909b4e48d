"""Whole publications composed of operators, and the catalogue of checked queries."""
