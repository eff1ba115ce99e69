"""Late-delivery models on Spark ML: preparation, baselines, training, evaluation, scoring."""
