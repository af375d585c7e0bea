"""Data-aware placement of work as Spark queries: content, catalog, placement, queues, graphs, state and control."""
