"""End-to-end plans and the registry of queries with their SQL oracles."""
