"""Plans built of operators, and the query catalogue."""
