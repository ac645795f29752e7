"""sources of the hiring analytics library."""
