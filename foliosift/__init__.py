"""foliosift: a Spark-native engine for questions over a sectioned document corpus."""
