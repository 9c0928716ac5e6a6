"""Queries over the driver tables, each with the SQL a second engine answers it with."""
