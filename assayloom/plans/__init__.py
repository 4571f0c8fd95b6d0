"""Views over the given tables, and the queries on them."""
