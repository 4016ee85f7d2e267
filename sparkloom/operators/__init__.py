"""Vector search, full-text search, graph traversal and changes to rows, over DataFrames."""
