"""logql: text or request to DataFrame."""
