"""A PySpark-native library for messy public registers, returns, texts and the panels made of them."""
