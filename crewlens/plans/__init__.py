"""plans of the hiring analytics library."""
