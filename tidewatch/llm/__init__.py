"""Operators for building training corpora: cleaning, de-duplication, mixing, packing and sharding of documents."""
