"""Bindings of the test tables and the queries over them."""
