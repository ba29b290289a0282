"""functions of tessella."""
