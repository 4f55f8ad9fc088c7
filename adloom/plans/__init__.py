"""Whole modes over state tables, and the registered queries."""
