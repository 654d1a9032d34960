"""Registered queries: each applies operators to whole given tables; oracles are the same in SQL."""
