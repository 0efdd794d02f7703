"""Training-data operators: one module each, plus the thin queries that apply them."""
