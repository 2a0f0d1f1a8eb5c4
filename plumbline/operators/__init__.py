"""DataFrame operators, one module for each family."""
