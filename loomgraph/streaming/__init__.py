"""Event-time extensions over Structured Streaming."""
