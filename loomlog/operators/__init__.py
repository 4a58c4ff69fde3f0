"""Operators over sources: union, filters, pages, aggregates, parsers, detection, inference, export."""
