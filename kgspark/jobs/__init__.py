"""Whole jobs: the demo graph and the graph build."""
