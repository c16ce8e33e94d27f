"""Where sequences, queries and indexes come from, and where results go."""
