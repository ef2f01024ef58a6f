"""arglake.operators."""
