"""Rules on unbounded tables."""
