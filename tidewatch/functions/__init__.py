"""Column functions and scaling helpers shared by the operators."""
