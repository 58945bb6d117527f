"""Catalogue, stored versioned tables, sessions and the SQL front end."""
