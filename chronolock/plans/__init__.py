"""Plans: composites of operators, and the queries over the shared test tables."""
