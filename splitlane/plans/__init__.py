"""Whole jobs composed of the operators, and the registered queries."""
