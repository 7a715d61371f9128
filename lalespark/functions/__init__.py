"""Column functions: sounds, harmony, tokens."""
