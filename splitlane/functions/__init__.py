"""Column functions: ids, hashing, identity maps, JSON bodies, scores."""
