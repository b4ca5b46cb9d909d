"""Views over the given tables, and the queries built on them."""
