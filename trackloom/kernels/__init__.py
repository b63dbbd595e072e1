"""Kernels of the detector-event engine."""
