"""The operators: profile, issues, row extraction, drift and the rest."""
