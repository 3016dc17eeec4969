"""silkgraph: transfer-graph and feature-table analytics on Spark."""
