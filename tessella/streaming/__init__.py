"""streaming of tessella."""
