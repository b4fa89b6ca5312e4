"""Registered queries: each operator applied to a fixture, with an independent SQL statement of its result."""
