"""Training-data operators: one module for each, their registered queries in `queries`."""
