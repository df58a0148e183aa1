"""Ready-made queries over the shared test tables, with their SQL counterparts."""
