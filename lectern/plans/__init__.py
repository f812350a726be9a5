"""Sessions and how the library reaches the executors."""
