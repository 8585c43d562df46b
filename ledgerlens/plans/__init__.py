"""Fact tables over the star schema and the registered, checkable queries."""
