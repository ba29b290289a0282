"""plans of tessella."""
