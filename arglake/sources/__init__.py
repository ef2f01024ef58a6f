"""arglake.sources."""
