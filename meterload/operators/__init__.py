"""Data operators, each a DataFrame-to-DataFrame function."""
