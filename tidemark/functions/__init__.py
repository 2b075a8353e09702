"""Column functions: text, time, signatures, probability, validation rules."""
