"""DataFrame-to-DataFrame operators; none reads a path."""
