"""streaming of the hiring analytics library."""
