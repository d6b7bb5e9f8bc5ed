"""functions of marlstone."""
