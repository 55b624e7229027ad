"""Query plans: report bundles and the registry of named queries with their oracle SQL."""
