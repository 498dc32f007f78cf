"""Operators that a training-data pipeline needs. Nothing else in brindle imports this."""
