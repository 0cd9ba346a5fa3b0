"""search: text or request to DataFrame."""
