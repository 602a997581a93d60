"""Search, index and balancing operators."""
