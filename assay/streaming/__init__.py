"""streaming of the test-quality warehouse."""
