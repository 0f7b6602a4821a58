"""Whole jobs composed from the operators: preparing the corpus and answering queries."""
