"""Sieveline: a PySpark-native catalog, curation and release engine."""
