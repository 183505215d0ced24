"""DataFrame-to-DataFrame operators, one module per stage of the graph build."""
