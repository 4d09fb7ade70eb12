"""Whole studies, and the registered table queries."""
