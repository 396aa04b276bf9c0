"""Column expressions: identities, canonical texts, types and rendering."""
