"""Training-data operators. Nothing outside this package imports it; each module holds one operator."""
