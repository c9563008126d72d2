"""streaming of the catalogue engine."""
