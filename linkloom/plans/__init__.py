"""Composite programs: registered queries and the SQL that checks them."""
