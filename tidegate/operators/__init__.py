"""DataFrame operators: cleaning, sampling, scaling, metrics, models, studies."""
