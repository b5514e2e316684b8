"""Training-data operators: decontamination, license scan, deduplication, sharding, PII, packing, classifiers.

Nothing else in the library imports this subpackage.
"""
