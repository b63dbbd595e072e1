"""Streaming of the detector-event engine."""
