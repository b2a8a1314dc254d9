"""Queries made of the operators, over the fixture tables."""
