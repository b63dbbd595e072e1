"""trackloom: detector-event analytics as DataFrame operators."""
