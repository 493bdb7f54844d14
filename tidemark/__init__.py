"""tidemark: life-cycle analytics for retrieval indexes and text corpora, as Spark DataFrame operators."""
