"""Relational operators: vocabulary and TF-IDF, splits, evaluation, graphs, classifiers."""
