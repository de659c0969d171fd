"""Fixed values and their optional overrides."""
