"""Column expressions: missing-value rules, survey numerics, nutrition scores."""
