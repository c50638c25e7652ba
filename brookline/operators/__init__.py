"""Inner sequences and collectors."""
