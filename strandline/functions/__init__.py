"""Column functions over typed values, and the fixed vocabulary."""
