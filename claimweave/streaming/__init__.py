"""Claims that arrive as files, and events by time."""
