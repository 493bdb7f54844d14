"""Column expressions: text cleaning, identity, time and vectors."""
