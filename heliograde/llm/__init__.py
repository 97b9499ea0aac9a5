"""Operators for preparing training text: each module is one operator, ``queries`` registers them."""
