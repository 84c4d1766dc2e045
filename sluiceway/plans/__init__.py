"""Fixture inputs, registered queries and their SQL counterparts."""
