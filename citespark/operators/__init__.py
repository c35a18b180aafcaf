"""DataFrame operators; each takes tables and returns tables."""
