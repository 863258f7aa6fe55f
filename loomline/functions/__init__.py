"""functions of the window analytics engine."""
