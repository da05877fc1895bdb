"""Whole rounds, the round engine and the registered queries."""
