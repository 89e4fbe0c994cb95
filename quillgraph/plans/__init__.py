"""Registered plans: named queries over the fixture tables with their SQL twins."""
