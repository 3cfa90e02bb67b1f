"""Whole jobs made of the operators, and the queries over the test tables."""
