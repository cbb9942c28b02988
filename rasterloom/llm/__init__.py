"""Training-data operators over tables of documents, pages, vectors and chats."""
