"""operators of marlstone."""
