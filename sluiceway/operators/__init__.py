"""Table steps: columns, SQL text, code, typed load, checks, profiles."""
