"""Topic reports: each takes canonical tables and returns the result tables of one topic."""
