"""Operators put together: the family read model, landscape jobs, registered queries."""
