"""sources of tessella."""
