"""Tessera: DataFrame operators for preparing and analysing text corpora on Spark."""
