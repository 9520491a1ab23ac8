"""Composed jobs and the join-size policy."""
