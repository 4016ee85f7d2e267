"""Live queries, maintained views and triggers over the change log of tables."""
