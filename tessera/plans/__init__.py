"""The snapshot store and the facade over it."""
