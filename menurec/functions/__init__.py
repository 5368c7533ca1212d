"""Column functions: boundary date diffs, decimal averages, hashing, prefix sums."""
