"""Media analytics on Spark: filters, timelines, sessions, places, search, people and curation over a media index."""
