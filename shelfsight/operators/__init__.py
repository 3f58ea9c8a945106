"""DataFrame-to-DataFrame operators, one module per part of the model."""
