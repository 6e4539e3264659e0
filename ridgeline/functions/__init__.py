"""Statistics as DataFrame expressions and small tables."""
