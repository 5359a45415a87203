"""Sources of weighted points and sinks of results."""
