"""loomgraph: property-graph analytics over documents and tables, as Spark DataFrame jobs."""
