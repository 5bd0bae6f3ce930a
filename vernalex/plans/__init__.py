"""vernalex plans: helpers that shape the physical plan."""
