"""DataFrame operators: validation, projection, sampling, rewards, losses, metrics, catalogue."""
