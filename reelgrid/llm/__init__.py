"""Operators that turn clip texts, answer logs and project files into training data."""
