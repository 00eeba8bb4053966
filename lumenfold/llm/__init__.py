"""Training-data operators: ten corpus-scale components and their driver queries."""
