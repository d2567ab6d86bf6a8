"""lexquarry: a Spark-native engine for hybrid passage and citation retrieval analytics."""
