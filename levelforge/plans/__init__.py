"""Queries over the driver's tables: each module has a family of them, beside the SQL that says the same."""
