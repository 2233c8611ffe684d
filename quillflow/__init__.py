"""quillflow: Spark-native document-to-ledger analytics."""
