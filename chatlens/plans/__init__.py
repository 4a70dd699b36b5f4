"""Named query plans over the supplied tables and their DuckDB oracle SQL."""
