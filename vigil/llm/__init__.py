"""Training-data operators on the ``documents``, ``labels``, ``benchmark`` and ``embeddings`` tables."""
