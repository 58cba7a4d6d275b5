"""Column helpers, distributed ranking and scalar probability functions."""
