"""Operators for preparing training text and vectors; each module's docstring states its method."""
