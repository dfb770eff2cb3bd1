"""Evidence analytics on Spark: claims, sources, verdicts and the reports over them."""
