"""Training-data operators: ten operators over documents and conversations, and their driver queries."""
