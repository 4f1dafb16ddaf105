"""Whole runs: configuration and the chain of stages."""
