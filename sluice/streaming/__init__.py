"""Micro-batch execution of the same operators."""
