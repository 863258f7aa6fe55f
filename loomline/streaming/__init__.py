"""streaming of the window analytics engine."""
