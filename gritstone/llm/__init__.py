"""Operators for building language-model training corpora; nothing else in gritstone imports this package."""
