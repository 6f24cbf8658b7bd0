"""Generated datasets and sampled frequencies."""
