"""Sources of loomgraph."""
