"""Named queries over the test tables, and SQL that says the same."""
