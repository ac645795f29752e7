"""operators of the hiring analytics library."""
