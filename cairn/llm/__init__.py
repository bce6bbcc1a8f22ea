"""Training-data operators over the tables documents, pages, embeddings and benchmark."""
