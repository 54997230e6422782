"""End-to-end plans, and the registered queries over the given tables."""
