"""Plans that compose operators, and the declared stages they belong to."""
