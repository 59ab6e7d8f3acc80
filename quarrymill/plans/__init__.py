"""The query catalogue: the operators applied to the supplied tables, with the same results in SQL."""
