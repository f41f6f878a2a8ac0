"""Functions of the dialect: SQL builders for typed values, Arrow-batched functions for documents."""
