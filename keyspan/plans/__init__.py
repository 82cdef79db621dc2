"""How plans are ordered, checked and reused."""
