"""Whole runs: their plan, their artifacts, their store, and the ways to call them."""
