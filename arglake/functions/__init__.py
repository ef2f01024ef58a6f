"""arglake.functions."""
