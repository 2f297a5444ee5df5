"""Reading events and posts, writing and reading the lake."""
