"""A PySpark-native engine for text-to-vocabulary analytics and spaced-repetition scheduling."""
