"""operators of the window analytics engine."""
