"""End-to-end plans and jobs built from the operators."""
