"""sources of the window analytics engine."""
