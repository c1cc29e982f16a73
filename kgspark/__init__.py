"""Knowledge-graph jobs for Spark: pages in, triples out, at cluster scale."""
