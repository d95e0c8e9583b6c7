"""textmill: chunking, indexing and retrieval evaluation of text corpora as Spark plans."""
