"""Query catalogue: each query with its ANSI-SQL counterpart."""
