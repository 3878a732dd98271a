"""hubflow.operators."""
