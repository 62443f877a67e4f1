"""Training-data operators: mixing, toxicity, archives, deduplication, secrets, packing, licences, fingerprints.

Nothing outside this subpackage imports it.
"""
