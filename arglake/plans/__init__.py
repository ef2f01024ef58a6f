"""arglake.plans."""
