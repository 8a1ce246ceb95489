"""Queries over the driver's tables, one per operator, each with its SQL oracle where SQL can express it."""
