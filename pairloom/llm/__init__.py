"""Operators on training text and large result tables; optional: nothing else in the package imports it."""
