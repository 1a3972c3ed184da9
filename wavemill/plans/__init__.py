"""Query catalogue: thin wrappers of the operators over the test tables, with SQL twins."""
