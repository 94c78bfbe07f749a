"""Whole plans, their queries and the SQL that checks them."""
