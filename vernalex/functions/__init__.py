"""vernalex functions."""
