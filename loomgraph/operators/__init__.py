"""Operators of loomgraph."""
