"""Query registry and multi-step plans."""
