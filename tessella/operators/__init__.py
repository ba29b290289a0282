"""operators of tessella."""
