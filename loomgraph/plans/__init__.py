"""Plans of loomgraph."""
