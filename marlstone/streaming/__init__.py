"""streaming of marlstone."""
