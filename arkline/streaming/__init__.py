"""Long-running work: tasks with states, and discovery of new files as a stream."""
