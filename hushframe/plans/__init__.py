"""Plan-time rewriting of schemas."""
