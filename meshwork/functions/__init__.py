"""Column expressions that the engine is built from."""
