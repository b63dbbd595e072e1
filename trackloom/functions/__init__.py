"""Functions of the detector-event engine."""
