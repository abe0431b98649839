"""Profiling, cleaning, features, sampling, models and evaluation."""
