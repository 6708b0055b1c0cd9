"""The runs a user starts, composed from the operators."""
