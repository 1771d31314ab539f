"""Readers and writers, and the normalisation of source feeds into gene-disease, gene-drug and drug-indication tables."""
