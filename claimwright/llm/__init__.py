"""Operators for training text: encoding, evaluation leaks, splitting. Nothing else imports this subpackage."""
