"""plans of marlstone."""
