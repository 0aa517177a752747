"""Track streams and their batch twins."""
