"""End-to-end plans of a study, composed from the operators."""
