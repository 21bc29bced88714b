"""Column functions: text clean-up, answer extraction, numbers, denotations, messages."""
