"""Operators on ranked pairs, hand-entered values and document texts. Nothing outside this package imports it."""
