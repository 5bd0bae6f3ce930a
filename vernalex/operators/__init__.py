"""vernalex operators."""
