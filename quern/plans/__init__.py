"""Plans compiled from graph patterns, traversal steps and task tables."""
