"""sources of the test-quality warehouse."""
