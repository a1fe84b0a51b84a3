"""The SELECT front-end and its planner."""
