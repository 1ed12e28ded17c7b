"""Registered queries, each with the SQL that says the same."""
