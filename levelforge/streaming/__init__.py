"""The job queue as batch replay and as a stream."""
