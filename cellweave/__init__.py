"""cellweave: DataFrame operators for multimodal spatial single-cell tables."""
