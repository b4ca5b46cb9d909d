"""DataFrame operators: windows, features, joins, health, stages, life and their checks."""
