"""Operators for preparing training data: ten operators and the queries over them.

Nothing else in the library imports this package."""
