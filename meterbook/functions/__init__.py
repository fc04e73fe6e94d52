"""Column expressions: text, time, JSON probing, naming, identity."""
