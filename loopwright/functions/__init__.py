"""Column expressions: text, JSON, fingerprints, scores and prompts."""
