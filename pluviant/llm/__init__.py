"""Training-data operators: each module holds one operator, `queries` their registered forms."""
