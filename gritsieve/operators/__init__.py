"""Relational operators over commits, file changes, hunks and ledgers."""
