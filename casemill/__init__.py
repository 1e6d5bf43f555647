"""casemill: a Spark-native document-extraction and data-cleaning engine."""
