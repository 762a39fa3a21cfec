"""Reading and writing events, and upkeep of the derived tables."""
