"""hubflow.plans."""
