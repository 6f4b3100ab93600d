"""Query plans by name."""
