"""Column and aggregate builders shared by the operators."""
