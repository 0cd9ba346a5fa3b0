"""PromQL: text to DataFrame."""
