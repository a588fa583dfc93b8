"""Column expressions without shuffles."""
