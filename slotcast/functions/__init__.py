"""Column expressions: time stamps, calendar, direction, errors."""
