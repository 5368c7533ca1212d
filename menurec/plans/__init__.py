"""Plans: join helpers, the registered queries and their SQL oracles."""
