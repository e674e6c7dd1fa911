"""plans of the test-quality warehouse."""
