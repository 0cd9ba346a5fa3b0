"""traceql: text or request to DataFrame."""
