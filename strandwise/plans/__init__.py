"""Whole queries composed of operators, with the SQL they are compared against."""
