"""Registered queries: the operators over the driver's tables, each with its SQL."""
