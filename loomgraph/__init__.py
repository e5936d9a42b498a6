"""loomgraph: code-knowledge-graph analytics expressed as Spark DataFrame jobs."""
