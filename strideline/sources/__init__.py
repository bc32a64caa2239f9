"""Reading raw event data and writing results."""
