"""Operators of the training-data pipeline on texts and vectors; nothing else imports this package."""
