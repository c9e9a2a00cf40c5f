"""Column expressions: geodesy, physics, time and text."""
