"""What is decided on the driver: the type graph, inference over aggregates, and schemas."""
