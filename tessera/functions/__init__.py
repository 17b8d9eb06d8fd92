"""Column functions: text, identifiers, coercion, classification."""
