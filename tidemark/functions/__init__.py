"""Column builders shared by all operators."""
