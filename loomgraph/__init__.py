"""loomgraph: typed dataflow, graph and table analytics expressed as Spark plans."""
