"""Collections that follow a stream of changes."""
