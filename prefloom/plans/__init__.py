"""End-to-end jobs composed of the operators."""
