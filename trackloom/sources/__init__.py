"""Sources of the detector-event engine."""
