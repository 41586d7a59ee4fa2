"""Question routing, tools and end-to-end plans."""
