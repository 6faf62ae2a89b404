"""Analytic operators: pure ``DataFrame -> DataFrame`` functions."""
