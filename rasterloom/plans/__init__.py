"""Plans: named queries, their SQL, parameters, the whole run and its controls."""
