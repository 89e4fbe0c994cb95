"""quillgraph: Spark-native document, vector and graph retrieval analytics."""
