"""Streaming of loomgraph."""
