"""DataFrame jobs: cohort, sequence, token, vector, retrieval, head, metric, prediction."""
