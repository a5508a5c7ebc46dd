"""Whole queries over the given tables, with SQL that must agree with them."""
