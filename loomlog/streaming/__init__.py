"""The stateless parsers on streams."""
