"""functions of the test-quality warehouse."""
