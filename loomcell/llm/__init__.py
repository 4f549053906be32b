"""Operators on text and matching for training data; optional, nothing else imports it."""
