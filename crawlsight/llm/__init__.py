"""Operators for training-data pipelines over documents and pages; nothing else imports this."""
