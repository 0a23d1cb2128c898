"""Session analytics on Spark: repetition detectors, verdicts and their evaluation as DataFrame jobs."""
