"""Whole jobs: training, scoring, and the registered queries."""
