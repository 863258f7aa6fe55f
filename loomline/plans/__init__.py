"""plans of the window analytics engine."""
