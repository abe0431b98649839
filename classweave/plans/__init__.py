"""Training, scoring and the registered queries."""
