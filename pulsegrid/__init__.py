"""pulsegrid: PySpark jobs over physiological recordings and text corpora."""
