"""Column builders: every scalar of the two spaces as a Catalyst expression."""
