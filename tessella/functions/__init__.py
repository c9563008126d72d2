"""functions of the catalogue engine."""
