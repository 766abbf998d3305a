"""The expression operators and the analytics built on them."""
