"""Whole query plans: windows, states, evaluation."""
