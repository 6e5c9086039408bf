"""DataFrame to DataFrame steps that the analytics are composed of."""
