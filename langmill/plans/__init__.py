"""Complete runs composed of operators."""
