"""Plans built from contexts and frames, and the catalogue of queries."""
