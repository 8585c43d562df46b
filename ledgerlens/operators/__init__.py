"""DataFrame -> DataFrame operators parameterised by a role mapping."""
