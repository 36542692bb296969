"""Running the automatic planner from a stream."""
