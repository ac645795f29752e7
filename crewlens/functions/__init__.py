"""functions of the hiring analytics library."""
