"""statuta: knowledge-graph retrieval over structured documents as Spark DataFrame operators."""
