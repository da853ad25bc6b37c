"""Leak detectors, splits, preparation steps and metrics as DataFrame operators."""
