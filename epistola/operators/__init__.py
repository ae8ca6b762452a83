"""Set-based operators over documents, labels and vectors."""
