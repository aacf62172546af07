"""DataFrame operators: cleaning, entities, vectors, clusters, reports."""
