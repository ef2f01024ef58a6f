"""arglake.streaming."""
