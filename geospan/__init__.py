"""Text in, located facts out: tagging, patterns, gazetteers, geocoding and their scoring as DataFrame plans."""
