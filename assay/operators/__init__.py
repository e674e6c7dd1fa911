"""operators of the test-quality warehouse."""
