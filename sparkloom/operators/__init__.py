"""Table operators: extraction, shaping, mapping, indexing, retrieval, documentation."""
