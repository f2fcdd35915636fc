"""notegraph: indexing, retrieval and evaluation of note collections on Spark."""
