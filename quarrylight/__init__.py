"""quarrylight: a Spark-native engine for retrieval, grounding and corpus preparation."""
