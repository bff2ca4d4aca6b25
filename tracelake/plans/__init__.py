"""Registered queries over the given tables, each with equivalent SQL."""
