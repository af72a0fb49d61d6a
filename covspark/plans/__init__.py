"""Work tables: what is missing, what is due, and how landed responses are applied."""
