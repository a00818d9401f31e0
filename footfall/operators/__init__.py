"""DataFrame operators by stage: reviews, cores, splits, sequences, pools, vectors, evaluation, runs."""
