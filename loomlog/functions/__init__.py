"""Column helpers: field references, text forms, timestamps."""
