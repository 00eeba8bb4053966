"""Plans: the engine's queries over the driver's tables."""
