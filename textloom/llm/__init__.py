"""Operators for preparing language-model training data; nothing else in textloom imports this folder."""
