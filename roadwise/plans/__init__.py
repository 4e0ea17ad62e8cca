"""The jobs, each a function from tables to a DataFrame."""
