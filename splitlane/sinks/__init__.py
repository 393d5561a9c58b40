"""Event tables, registry versions, sample dumps and training metrics as written tables."""
