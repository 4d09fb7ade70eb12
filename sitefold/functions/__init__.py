"""Column helpers and numeric tails."""
