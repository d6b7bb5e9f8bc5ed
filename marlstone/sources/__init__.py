"""sources of marlstone."""
