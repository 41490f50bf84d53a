"""quillspark: Spark-native analytics for long, structured documents."""
