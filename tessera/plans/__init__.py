"""Numerical solvers for the small problems that follow a sketch, and whole pipelines."""
