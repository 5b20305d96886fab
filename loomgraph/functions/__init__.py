"""Functions of loomgraph."""
