"""Column functions: hashing, quantiles, running totals."""
