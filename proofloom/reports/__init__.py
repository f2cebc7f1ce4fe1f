"""CSV, JSON and text renderings of operator results."""
