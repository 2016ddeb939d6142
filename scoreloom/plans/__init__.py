"""Bindings of the operators to the driver tables, and their reference SQL."""
