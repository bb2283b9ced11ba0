"""PySpark-native analytics over tool-call spans, agent sessions and text corpora."""
