"""Registered queries: each is a Spark plan and, next to it, SQL written on its own."""
