"""Search, index build and recipes."""
