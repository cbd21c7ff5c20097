"""Text retrieval and activity analytics as plain DataFrame -> DataFrame functions."""
