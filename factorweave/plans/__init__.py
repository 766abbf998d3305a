"""Alpha expressions and their compilation to DataFrame plans."""
