"""Column and DataFrame building blocks shared by the operators."""
