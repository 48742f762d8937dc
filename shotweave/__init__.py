"""Retrieval and corpus analytics over collections of time-coded media metadata, as DataFrame operators."""
