"""Movement analytics as DataFrame-to-DataFrame functions on Spark."""
