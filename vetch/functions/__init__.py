"""Column expressions; nothing here reads or shuffles."""
