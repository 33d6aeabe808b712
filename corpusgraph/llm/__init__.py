"""Training-data operators: language, search, token output, archives, quality,
packing, personal data, near-duplicates, mixing, toxicity, source divergence, benchmark
contamination and manifests.

Nothing else in the library imports this subpackage.
"""
