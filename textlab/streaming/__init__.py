"""Scoring of arriving rows and running label counts over them."""
