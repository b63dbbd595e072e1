"""Operators of the detector-event engine."""
