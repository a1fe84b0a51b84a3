"""Expressions: predicates, arithmetic, statistics."""
