"""vernalex sources."""
